"""Operators that prepare crawled text as training data. Nothing outside this subpackage imports it."""
