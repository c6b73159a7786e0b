"""Risk propagation over commercial networks, written as Spark DataFrame jobs.

Sub-packages:

* ``sources``   – readers, writers, lineage cuts and the test-table mapping
* ``functions`` – column expressions and distributed exact statistics
* ``operators`` – seeds, forces, propagation, labels, communities, reports
* ``plans``     – end-to-end scenarios and the SQL used to check them
* ``streaming`` – incremental seed maintenance from an alert stream
"""

__version__ = "0.1.0"
