"""Sources: push envelopes, change feed, messages, attachments, stored tables."""
