"""Structured Streaming forms of acquisition and flagging."""
