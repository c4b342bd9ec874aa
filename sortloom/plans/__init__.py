"""Planning arithmetic: stripes, chunks, merges, cost."""
