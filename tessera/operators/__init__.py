"""DataFrame operators of curation and evaluation."""
