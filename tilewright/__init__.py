"""A PySpark-native engine for image atlases, block codecs, caches and animation streams."""
