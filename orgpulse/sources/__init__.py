"""Reading raw report sheets, resolving their headers, writing result tables."""
