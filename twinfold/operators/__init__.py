"""DataFrame -> DataFrame operators over paired records."""
