"""Text-quality analytics as DataFrame operators."""
