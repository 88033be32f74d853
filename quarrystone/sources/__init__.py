"""Sources: schedule exports, note vaults, document folders, canvases and web pages."""
