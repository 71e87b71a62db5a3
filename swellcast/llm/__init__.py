"""Training-data operators: deduplication, language ID, URL and HTML cleaning,
tokenising, LM scoring and packing of document corpora. Nothing else in the
library imports this subpackage."""
