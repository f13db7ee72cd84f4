"""Sources (catalog loads, script corpus) and sinks (schema conformance,
positional overwrite, exports, partitioned run store)."""
