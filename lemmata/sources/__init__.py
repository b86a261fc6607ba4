"""Facts from tables and files, and sessions to and from storage."""
