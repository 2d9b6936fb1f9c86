"""Training-data operators over text tables.

One module per operator, `queries.py` registers them for the driver.  Nothing
outside this subpackage imports it.
"""
