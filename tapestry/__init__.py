"""tapestry — consolidate source tables into wide nested entity rows and document
source-to-target mappings, as Spark DataFrame / SQL jobs.

Sub-packages:
  sources    catalog loads, script corpus scans, schema conformance, sinks/exports
  functions  Column-level helpers (names, keys, codes, arrays, text similarity)
  operators  DataFrame-level operators (lookups, nesting, quality rules, script
             extraction, lineage, reconciliation, review/run store)
  plans      end-to-end jobs (entity profile, mapping document) and the
             registered query set
  streaming  micro-batch adapters for the stateless operators
"""

__version__ = "0.1.0"
