"""Runnable jobs over the library's operators; see README."""
