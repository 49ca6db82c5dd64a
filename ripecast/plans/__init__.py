"""End-to-end jobs: from the stored tables to a report."""
