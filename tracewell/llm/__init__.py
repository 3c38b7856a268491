"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Each operator takes and
returns DataFrames; the thin ``op*`` queries of ``registry`` derive digest
columns from what the operators return.

Conventions that hold for every operator unless its docstring says otherwise:
a null text counts as an empty text; a null id is kept as a group or row of its
own; an empty table gives an empty result of the same schema; only the named
input columns are read, so extra columns, whatever their names, do no harm and
are not carried along.
"""
