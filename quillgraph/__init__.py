"""PySpark-native engine for versioned, multi-tenant knowledge graphs."""
