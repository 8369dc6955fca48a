"""Readers and writers: file scans, index directories, evaluation cases, diffs."""
