"""DataFrame operators over event logs."""
