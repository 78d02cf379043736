"""sparkshelf: catalog analytics operators as PySpark DataFrame transformations."""
