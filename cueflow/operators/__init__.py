"""DataFrame operators over cues, clips, speech segments, logs and results."""
