"""Readers and writers: captions, video metadata, notes, file inventories, subtitles, results."""
