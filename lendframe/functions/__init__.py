"""Row-wise column expressions (no aggregate, no shuffle)."""
