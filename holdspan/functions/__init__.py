"""Column functions: values, calendars, buckets."""
