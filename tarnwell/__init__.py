"""tarnwell: a PySpark-native engine for retrieval, chat memory, evaluation and text data."""
