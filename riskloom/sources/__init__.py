"""Readers: files of a repository, reports of tools, database catalogues, logs."""
