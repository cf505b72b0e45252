"""Named stages with memory of what is done."""
