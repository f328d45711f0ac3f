"""Nothing here: the reference has no streams, windows over time or late data. Dated evidence is batch input."""
