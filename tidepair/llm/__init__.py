"""Operators for training-data pipelines over the documents table; nothing else imports them."""
