"""Operators for preparing training text: dedup, scans, token files, search, mixing, WARC, BPE."""

from pyspark import cloudpickle

from latecast.llm import (
    bloom, byte_bpe, files, memory, near_dup, phrases, pieces, quality, runs, secret_crf,
    substrings, token_file, topk, warc,
)

# What runs inside Python workers travels with the job: executors need no copy of this package.
for _module in (bloom, byte_bpe, files, near_dup, pieces, quality, runs, secret_crf, token_file, topk, warc):
    cloudpickle.register_pickle_by_value(_module)
