"""DataFrame to DataFrame operators; none collects its input."""
