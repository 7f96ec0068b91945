"""Training-data operators; `plans` holds their registered queries."""
