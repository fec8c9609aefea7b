"""Part of urlloom."""
