"""Part of talkscale: plans."""
