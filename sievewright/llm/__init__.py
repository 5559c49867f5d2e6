"""Operators for large training-data pipelines, each a DataFrame-to-DataFrame function; nothing else imports this package."""
