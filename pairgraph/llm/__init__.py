"""Operators that prepare training text at corpus scale, one module each.

Nothing outside this subpackage imports it. Every operator takes DataFrames, names its columns by parameter
and returns a lazy DataFrame, apart from intermediate tables that it writes to the shared folder.
"""
