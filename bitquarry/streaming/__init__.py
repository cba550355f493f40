"""The stateless functions on streams."""
