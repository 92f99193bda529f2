"""Context governance for LLM assistants as Spark jobs over tables and streams."""
