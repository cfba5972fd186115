"""Complete calculations put together from the operators."""
