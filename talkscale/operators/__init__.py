"""Part of talkscale: operators."""
