"""Streaming adapters.

The source system is batch only (no stream, watermark or state anywhere), so
nothing here is a new operator.  The normalisation, code translation and
data-quality operators are stateless projections, so they run unchanged on a
streaming DataFrame; ``quality_stream`` wires them to a file stream with an
exactly-once file sink whose checkpoint lives in the cluster's shared
checkpoint folder.
"""

from tapestry.streaming.quality import quality_stream  # noqa: F401
