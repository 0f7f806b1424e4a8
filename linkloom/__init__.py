"""linkloom — link-to-taxonomy labeling expressed as Spark DataFrame and Structured Streaming jobs.

Sub-packages:
  functions/  Column-expression builders (URL predicate and canonical form, slug, display helpers)
  sources/    post-stream parsing, label-log and settings tables
  operators/  link extraction, article dimension, active authors, categories, labels, sequences, merges,
              taxonomy and reports
  plans/      fixtures derived from the driver tables and the named queries built on them
  streaming/  Structured Streaming versions of the label stream and its live reports
"""

__version__ = "0.1.0"
