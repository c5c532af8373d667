"""tessera: media-library analytics and training-data preparation as PySpark jobs."""
