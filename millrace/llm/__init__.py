"""Operators that prepare source code and documents for training; nothing else imports this package."""
