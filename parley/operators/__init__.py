"""DataFrame -> DataFrame steps; nothing here collects rows to the driver."""
