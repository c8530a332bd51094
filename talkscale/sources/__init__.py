"""Part of talkscale: sources."""
