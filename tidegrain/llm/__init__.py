"""Operators for text and record problems of training-data pipelines; nothing else imports this subpackage."""
