"""Readers and writers of images and decoded tables."""
