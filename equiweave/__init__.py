"""Entity alignment between knowledge graphs as DataFrame operations."""
