"""End-to-end plans, and synthetic inputs derived from the star schema."""
