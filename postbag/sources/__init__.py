"""Reading contact files and pages, and the log and outbox tables."""
