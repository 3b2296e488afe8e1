"""One function per named analysis.

Each works on all entities at once; what a dashboard would let the user select is an optional
argument.  Rows of one selected entity come sorted; results for all entities are left in no
particular order unless they are small.  Sort orders are total, so results are reproducible and
equal leading keys do not pile up in one sort task.
"""
