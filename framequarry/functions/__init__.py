"""See the package README for this layer."""
