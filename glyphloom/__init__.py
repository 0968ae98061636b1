"""glyphloom: online token discovery and token-graph analytics on PySpark."""
