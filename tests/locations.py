"""Folders of the given tables. Not in conftest: tests/llm has a conftest of its own, under the same module name."""

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
