"""Analytics over conversation corpora with Spark: calls, notes, documents, search, entities and their upkeep."""
