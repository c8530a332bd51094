"""Part of talkscale: streaming."""
