"""Readers and writers: messages, request batches, replies, run reports."""
