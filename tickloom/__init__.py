"""tickloom: market time-series research operators as PySpark DataFrame functions.

Series time is a BIGINT column of epoch microseconds (``ts``), so every rule is
independent of the session time zone.  ``functions.scalars.micros`` converts.
"""
