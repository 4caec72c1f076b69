"""Part of the block-transform engine."""
