"""Readers and writers: JSON postings, envelopes, CV text files, versioned tables."""
