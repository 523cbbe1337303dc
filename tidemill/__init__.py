"""Analytics over message and document corpora, written as Spark plans."""
