"""DataFrame -> DataFrame operators; every one is lazy and skew-aware."""
