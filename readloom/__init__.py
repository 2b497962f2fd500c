"""Sequencing-read analytics on DataFrames: scans, trimming, joins, duplicate removal, intervals, statistics, alignment."""
