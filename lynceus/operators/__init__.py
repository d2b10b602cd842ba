"""DataFrame operators of the screening service."""
