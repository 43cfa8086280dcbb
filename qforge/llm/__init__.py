"""Training-corpus operators: near-dedup, WARC derivatives, token files, decontamination and more."""
