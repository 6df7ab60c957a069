"""Settlement-landscape analytics as DataFrame operators."""
