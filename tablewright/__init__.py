"""Dashboard analytics as Spark DataFrame functions.

``plans`` holds one function per named analysis; ``operators`` the relational building
blocks they share; ``functions`` column expressions; ``sources`` readers, writers and
option lists.  Every function takes DataFrames (plus plain Python filter values) and returns
a lazy DataFrame.
"""
