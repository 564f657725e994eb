"""textloom: text, speech and training-data processing as plain PySpark DataFrame functions."""
