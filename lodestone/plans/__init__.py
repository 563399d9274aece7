"""Whole analyses, composed from operators over one parse."""
