"""skein: a PySpark-native engine for network, time-series and text analytics."""
