"""docscope: a PySpark-native analytics engine for scholarly documents."""
