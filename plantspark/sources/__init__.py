"""Readers and writers: drawings, procedures, labels, annotations and predictions."""
