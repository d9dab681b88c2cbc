"""See the README for what stands here."""
