"""DataFrame operators of the design-evidence engine; none collects rows to the driver."""
