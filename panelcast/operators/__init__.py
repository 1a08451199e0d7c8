"""DataFrame -> DataFrame operators over daily panels."""
