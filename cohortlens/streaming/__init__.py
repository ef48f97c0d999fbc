"""The stateless operators on streams, and their counters as streaming aggregations."""
