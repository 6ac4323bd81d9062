"""Content security and analytics over tables of documents, as Spark DataFrame operators."""
