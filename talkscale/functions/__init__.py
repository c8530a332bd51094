"""Part of talkscale: functions."""
