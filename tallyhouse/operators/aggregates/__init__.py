"""Grouped metrics per day, entity and type.

Every function is one ``groupBy.agg`` plan: partial aggregation per task, one
shuffle on the group keys. ``ordered=False`` leaves out the final range shuffle
when the result is written or joined rather than shown.
"""
